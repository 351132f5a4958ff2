"""Relational, spatial, graph and quality operators over feature layers."""
