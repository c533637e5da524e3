"""sources of the egress library."""
