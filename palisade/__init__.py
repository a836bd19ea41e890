"""Application-security analytics on Spark DataFrames."""

from palisade.session import get_session

__all__ = ["get_session"]
__version__ = "0.1.0"
