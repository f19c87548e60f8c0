"""tessera: retrieval, template-driven querying and SQL evaluation on Spark.

Subpackages
-----------
sources    readers, sinks and table maintenance (parquet, SQL, JDBC, NDJSON, logs)
functions  column functions: text chunking, hashing, vectors, parameters, SQL text
operators  relational building blocks, vector search, catalog profiling,
           evaluation, result tools and the analytic question pack
plans      end-to-end jobs: prompt answering, index build, page ingest, question batches
streaming  Structured Streaming forms of ingest, embedding, usage and caching
"""

__version__ = "0.1.0"
