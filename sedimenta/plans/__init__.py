"""Helpers that decide where a plan is cut or broadcast."""
