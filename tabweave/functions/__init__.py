"""SQL expressions as text: hash randomness, the normal law, quantiles, repairs.

Expressions are built as Spark SQL text and parsed once per projection.  A model
of a wide table needs tens of thousands of operators; as text they cost
milliseconds, as single Column calls minutes.
"""
