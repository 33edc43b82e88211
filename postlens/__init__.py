"""postlens: analytics over tables of short posts, as Spark DataFrame operators."""
