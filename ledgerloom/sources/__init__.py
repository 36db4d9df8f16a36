"""Readers of catalog workspaces, payloads and provider listings."""
