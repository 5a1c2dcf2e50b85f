"""Dashboards, overlays, reports and exports over the standard tables."""
