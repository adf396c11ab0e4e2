"""storelens: storage forensics over versioned object stores, as PySpark DataFrames."""
