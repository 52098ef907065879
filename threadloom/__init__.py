"""threadloom: analytics over two-party conversation archives, as Spark plans."""
