"""Training-data operators: ten corpus-scale components and their registered queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only when it is present.
"""
