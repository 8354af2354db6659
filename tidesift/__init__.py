"""tidesift: a batch analytics library of lazy DataFrame operators on Spark."""
