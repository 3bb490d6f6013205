"""tessera: a retrieval-pipeline engine on Spark DataFrames.

Files become long-form sheet rows, rows become chunks, chunks become vectors,
questions become hits, contexts, prompts, request bodies and answers.  Every
operator is a ``DataFrame -> DataFrame`` function (use with ``df.transform``);
no operator collects data to the driver.
"""

__version__ = "0.1.0"
