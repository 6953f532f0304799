"""DataFrame operators over token and chunk rows."""
