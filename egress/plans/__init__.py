"""plans of the egress library."""
