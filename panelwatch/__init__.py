"""Analytics over environmental and health panels: many places observed over time."""
