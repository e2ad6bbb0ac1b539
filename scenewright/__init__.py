"""scenewright: scene metadata, task compilation and grading as Spark plans."""

__version__ = "0.1.0"
