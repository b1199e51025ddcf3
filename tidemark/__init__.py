"""tidemark: trend and labour-market analytics on Spark DataFrames."""
