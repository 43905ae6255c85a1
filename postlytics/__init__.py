"""postlytics: social-text analytics as Spark DataFrame and Column operators.

Layout:
  functions/  Column -> Column expressions (text, labels, prompts, embeddings)
  operators/  DataFrame -> DataFrame jobs (features, sampling, metrics, graph, ...)
  sources/    readers and sinks (posts, run logs, predictions)
  plans/      the registered end-to-end queries and their SQL oracles
  streaming/  Structured Streaming forms of the run-log jobs
"""

__version__ = "0.1.0"
