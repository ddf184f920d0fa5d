"""Set-oriented storefront operators (reads, joins, aggregates, changes)."""
