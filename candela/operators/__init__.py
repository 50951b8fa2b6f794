"""Market-structure operators: DataFrame in, DataFrame out, one row group for each (symbol, tf)."""
