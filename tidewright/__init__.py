"""Tidewright: continuous-query analytics over keyed, mutable topics, planned by Spark."""

from tidewright.catalog import Engine, TopicDef, ViewDef

__all__ = ["Engine", "TopicDef", "ViewDef"]
