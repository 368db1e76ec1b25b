"""rankloom: fusion of ranked search results and web content analytics on Spark.

The core subpackages never import ``rankloom.llm``; that one may be removed without
effect on the rest.
"""
