"""Message sources and the stored tables."""
