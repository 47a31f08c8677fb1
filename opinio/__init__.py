"""opinio: news-opinion analytics expressed as Spark DataFrame jobs.

Sub-packages
------------
sources    readers for the driver tables, the news model derived from them,
           stop words, lexicons, JSON/CSV inputs, stored web pages, sinks
functions  column-expression helpers (strings, dates, hashing, vectors, logits)
operators  validation, versioning, insert-ignore merges, control/to-do sets,
           text analytics (sentiment, topics, corpus preparation)
plans      reporting marts and data-quality reports, plus the query registry
streaming  micro-batch forms of the polling jobs
"""

__version__ = "0.1.0"
