"""Sources and sinks: table loading, fixture derivation, result writers."""
