"""DataFrame to DataFrame operators over the events and incidents tables."""
