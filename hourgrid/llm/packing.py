"""Order-preserving packing by dynamic programming.

Documents are laid end to end within a shard, in the order in which its rows are read; the stream is cut into sequences of at most
``limit`` tokens. A cut at a document's end costs nothing, one at a sentence's end a little, any other more; a
sequence costs its padding besides. ``best[j] = min over i of best[i] + padding(j - i) + truncation(j)`` over the
window ``j - limit <= i < j``: as padding is ``limit - (j - i)``, the minimum of ``best[i] + i`` over a sliding
window decides, which a monotone queue of candidate cuts gives in amortised constant time.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.common import bounded_batches, read_table

LIMIT = 4096
END_ID = 2
#: What a cut costs besides padding, in tokens.
SENTENCE_CUT, WORD_CUT = 4, 16
#: Tokens between the cuts that are allowed inside sentences.
GRID = 128
#: Sequences that one dynamic program covers; a task holds that many and one document.
HORIZON = 64
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 400_000
#: Python's white space that the tokenizer's pattern takes for symbols.
ODD_SPACE = re.compile("[\x1c-\x1f]")
PUNCTUATION = re.compile(r"[!-&(-/:-@\[-`{-~]+")
_PRINTABLE = frozenset([*range(33, 127), *range(161, 173), *range(174, 256)])
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
#: ASCII punctuation without apostrophes at the end of a word, after a letter or digit.
TAIL = re.compile("(?<=[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])[!-&(-/:-@\\[-`{-~]+$")


@lru_cache(1 << 16)
def glyph(char: str) -> str:
    """How a byte-level vocabulary spells a character: printable bytes of Latin-1 as themselves, the others, in order, from 256 on."""
    return "".join(chr(b) if b in _PRINTABLE else chr(256 + _OTHERS.index(b)) for b in char.encode())


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts by a tokenizer whose words never cross white space, each distinct word encoded once.

    A trailing run of ASCII punctuation is a word of its own for such a tokenizer, and the tokenizer folds case; so
    "Erer," and "erer" share the entry of "erer". Texts for which a fold or split of ours could differ from the
    tokenizer's go through it whole.
    """

    def __init__(self, path: str, size: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size, self.known, self.older = size, {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_sentence = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_sentence[[i for token, i in vocabulary.items() if token.endswith((".</w>", "!</w>", "?</w>"))]] = True

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, word: str) -> bytes:
        """Ids of a word that is not known, as bytes; it and its parts are known then.

        Entries live in two generations: a word of the older one moves up when it is met, and when the younger is full it
        becomes the older, so that frequent words stay.
        """
        if (ids := self.known.get(word)) is not None:
            return ids
        ids = self.older.get(word)
        if ids is None:
            cut = TAIL.search(word)
            if cut:
                ids = self._learn(word[: cut.start()]) + self._learn(cut[0])
            elif word.isalpha() or PUNCTUATION.fullmatch(word):
                # A run of letters, or of ASCII punctuation without apostrophes, is one word to the tokenizer: its model
                # takes it without normalising and splitting again.
                ids = array("I", [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else "".join(map(glyph, word)))]).tobytes()
            else:
                ids = self.plain(word).tobytes()
        self.known[word] = ids
        return ids

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts of ids after which a sentence ends)."""
        low = text.lower()
        if not text.isascii() and ("Σ" in text or "İ" in text or not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low))) or ODD_SPACE.search(text):
            return self.plain(text), np.zeros(0, dtype=np.int64)
        chunks = low.split()
        if len(self.known) > self.size // 2:
            self.older, self.known = self.known, {}
        parts = list(map(self.known.get, chunks))
        if None in parts:
            k = -1
            for _ in range(parts.count(None)):
                k = parts.index(None, k + 1)
                parts[k] = self._learn(chunks[k])
        ids = np.frombuffer(b"".join(parts), dtype="<u4")
        return ids, np.flatnonzero(self.ends_sentence[ids]) + 1


def plan_cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, limit: int = LIMIT, sentence_cut: int = SENTENCE_CUT, word_cut: int = WORD_CUT, grid: int = GRID) -> list[int]:
    """Cuts (token positions, increasing) of a stream, its end among them.

    Candidates are document ends (no cost), sentence ends and every ``grid``-th token. A sequence pays its padding to
    ``limit``; one of half or a quarter of it pays none.
    """
    total = int(doc_ends[-1])
    cost = dict.fromkeys(range(grid, total, grid), word_cut)
    cost.update(dict.fromkeys(sentence_ends.tolist(), sentence_cut))
    cost.update(dict.fromkeys(doc_ends.tolist(), 0))
    cost.pop(0, None)
    best, back = {0: 0}, {}
    queue = deque([(0, 0)])  # (position, best + position): values rise from front to back
    sizes = (limit // 2, limit // 4)  # shorter powers of two only at the end of a shard, see tail_cuts
    for j in sorted(cost):
        while queue[0][0] < j - limit:
            queue.popleft()
        origin, value = queue[0]
        found = value + limit - j
        for size in sizes:
            if (k := best.get(j - size)) is not None and k < found:
                found, origin = k, j - size
        found += cost[j]
        best[j], back[j] = found, origin
        while queue and queue[-1][1] >= found + j:
            queue.pop()
        queue.append((j, found + j))
    cuts, j = [], total
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def tail_cuts(length: int, limit: int = LIMIT) -> list[int]:
    """Cuts of a last, short sequence into powers of two, which need no padding; few left over stay one sequence."""
    if limit - length <= 64:
        return [length]
    cuts, at = [], 0
    while at < length:
        at += 1 << ((length - at).bit_length() - 1)
        cuts.append(at)
    return cuts


class Packer:
    """Streams documents into pieces; holds ``HORIZON`` sequences and one document."""

    def __init__(self, first_sequence: int, limit: int = LIMIT):
        self.sequence, self.limit, self.held, self.tokens = first_sequence, limit, [], 0

    def add(self, name, ids: np.ndarray, ends: np.ndarray) -> Iterator[dict]:
        self.held.append((name, ids, ends, 0))
        self.tokens += len(ids)
        if self.tokens >= HORIZON * self.limit:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[dict]:
        if not self.held:
            return
        docs, self.held = self.held, []
        doc_ends = np.cumsum([len(ids) - start for _, ids, _, start in docs])
        begins = doc_ends - [len(ids) - start for _, ids, _, start in docs]
        sentences = np.concatenate([ends[ends > start] - start + b for (_, _, ends, start), b in zip(docs, begins.tolist(), strict=True)])
        cuts = plan_cuts(doc_ends, sentences, self.limit)
        # The last sequence waits for what comes after it; at the end of the shard it is cut into powers of two.
        before = cuts[-2] if len(cuts) > 1 else 0
        cuts = cuts[:-1] + ([before + c for c in tail_cuts(cuts[-1] - before, self.limit)] if last else [])
        at = k = 0
        for cut in cuts:
            begin = at
            while at < cut:
                name, ids, _, start = docs[k]
                size = min(cut, int(doc_ends[k])) - at
                first = start + at - int(begins[k])
                piece = ids[first : first + size]
                yield {"doc_id": name, "start": first, "length": size, "ids_crc32": zlib.crc32(piece.tobytes()), "doc_tokens": len(ids), "sequence_id": self.sequence, "offset": at - begin, "ids": piece}
                at += size
                k += at == doc_ends[k]
            self.sequence += 1
        self.tokens = 0
        for name, ids, ends, start in docs[k:]:
            self.held.append((name, ids, ends, start + max(0, at - int(begins[k]))))
            self.tokens += len(ids) - self.held[-1][3]
            k += 1


_encoders: dict[str, WordEncoder] = {}


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, limit: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoder = _encoders.setdefault(tokenizer, None) or WordEncoder(tokenizer)
    _encoders[tokenizer] = encoder  # a worker that is used again keeps its words
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.list_(pa.int32()))])
    packer = Packer(TaskContext.get().partitionId() << 32, limit)
    end = np.array([end_id], dtype="<u4")

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([r[c] for r in rows], pa.int64()) for c in schema.names[:-1]]
        if with_ids and rows:
            flat = np.concatenate([r["ids"] for r in rows]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(np.cumsum([0, *[r["length"] for r in rows]]).astype(np.int32), pa.array(flat)))
        else:
            columns.append(pa.nulls(len(rows), schema.types[-1]))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        rows: list[dict] = []
        for name, text in zip(batch.column("id"), batch.column("text"), strict=True):
            ids, ends = encoder.encode(text.as_py() or "")
            rows += packer.add(name.as_py(), np.concatenate([ids, end]), ends)
            if len(rows) >= 1024:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)
    yield batch_of(list(packer.flush(True)))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and ``ids``.

    Every partition of ``docs`` is a shard that is packed in its own order; nothing is shuffled, and a task that runs
    again gives the same pieces. A null text is empty and has the end id alone; null ids and rows that repeat are packed
    as they come; a text longer than a sequence goes over several. ``tokenizer`` is the path of a vocabulary file that
    every executor has. Other columns are ignored; an empty table gives no rows.
    """
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    return rows.mapInArrow(partial(_pack, tokenizer=tokenizer or tokenizer_path(), limit=limit, end_id=end_id, with_ids=with_ids), schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(read_table(spark, sf_dir, "documents"), with_ids=False).drop("ids")
