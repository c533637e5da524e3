"""operators of the egress library."""
