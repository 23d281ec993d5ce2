"""Record linkage for product-like tables on Spark, and, in linkforge.llm, operators for training corpora."""
