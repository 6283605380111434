"""Plan building blocks: durable cuts, order-dependent aggregates, size-checked joins."""
