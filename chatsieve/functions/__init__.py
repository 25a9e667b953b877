"""Expressions as Spark SQL text.

Each function returns the text of one SQL expression, built from the texts of
its arguments, for ``selectExpr`` and ``F.expr``. One text is one call into the
JVM, where a tree of Column calls takes one round trip per node.
"""
