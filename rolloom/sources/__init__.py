"""Reading and writing the files of a data pipeline."""

from .files import *  # noqa: F403
