"""Analytics over language-model reasoning evaluations, as Spark DataFrames."""
