"""nearbox: box, nearest-neighbour and text-similarity queries over tables, on Spark."""
