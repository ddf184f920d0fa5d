"""shopframe: storefront analytics as Spark DataFrame operators.

Every operator takes DataFrames (a dict ``t`` of storefront tables) and returns
DataFrames; nothing is collected to the driver. A per-user or per-product
request parameter of the original web shop becomes a join key or a grouping
key, so one Spark job answers the question for every user / product at once.
"""

__version__ = "0.1.0"
