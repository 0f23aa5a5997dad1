"""Queries; importing a module registers what it holds."""
