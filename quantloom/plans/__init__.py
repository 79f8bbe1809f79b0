"""Requests and responses of the engine's operations."""
