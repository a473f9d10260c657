"""Shipment-plan optimisation as set operators (no per-scenario solver loop)."""
