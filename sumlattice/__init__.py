"""Short additive scoring scales, searched exhaustively and validated honestly, on Spark."""
