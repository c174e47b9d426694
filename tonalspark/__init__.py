"""Mood, similarity and catalogue analytics as Spark DataFrame programs."""
