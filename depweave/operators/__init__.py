"""Graph, store, contract and report operators: DataFrame in, DataFrame out."""
