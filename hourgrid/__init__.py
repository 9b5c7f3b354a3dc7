"""Point-in-time hourly state, forecasting and backtesting on Spark."""
