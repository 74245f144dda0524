"""Measurement and plan inspection."""
