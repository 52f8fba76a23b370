"""attesta: claim checking over large text collections, written as Spark jobs."""

from attesta.config import VerifyConfig
from attesta.session import build_session

__all__ = ["VerifyConfig", "build_session"]
