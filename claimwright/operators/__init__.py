"""Set-oriented operators over claims, entities, edges, text and evaluation tables."""
