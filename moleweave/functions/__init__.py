"""Column functions over molecules, and the small parsers behind them."""
