"""Runnable jobs over the library: ``python -m jobs.line_origins`` and ``python -m jobs.responsibility``."""
