"""Conversation analytics on Spark: transcripts, detectors, summaries, live sessions."""

from __future__ import annotations

import os

__version__ = "0.1.0"


def importable(spark) -> None:
    """Let Python workers find this package where it is installed, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
