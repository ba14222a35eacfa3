"""Column functions and the kernels behind them."""
