"""functions of the egress library."""
