"""corpusq: document corpora, retrieval and chat memory as Spark DataFrame jobs."""

from corpusq.config import EngineConfig
from corpusq.session import build_session

__all__ = ["EngineConfig", "build_session"]
