"""Stateful operators over streams of requests and events."""
