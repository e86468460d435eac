"""Whole plans composed of operators, and seed tables."""
