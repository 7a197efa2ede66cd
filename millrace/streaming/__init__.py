"""The event log: contract, landing as Structured Streaming, adapter, edge recovery."""
