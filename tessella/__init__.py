"""Tessella: structural analytics of software archives as Spark DataFrame jobs."""
