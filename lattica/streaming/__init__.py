"""Streaming counterparts of stateful panel operators."""
