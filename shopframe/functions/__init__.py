"""Column functions: predicates, text helpers, pricing and lifecycle rules."""
