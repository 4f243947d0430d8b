"""The three model pipelines and their evaluation."""
