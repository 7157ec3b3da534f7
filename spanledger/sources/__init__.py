"""Readers with explicit schemas for the tables and records the operators work on."""
