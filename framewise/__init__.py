"""Analytics over per-frame detection tables, built on Spark DataFrames."""
