"""Training-data operators (thirteen operators and their queries).

Nothing outside this folder imports it; ``__spark_entry__.py`` registers the
queries only when the folder is present.
"""
