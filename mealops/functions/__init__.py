"""Column-level building blocks. Every function returns a Column (or adds
columns to a frame) built from JVM-side expressions only."""

from .numeric import *  # noqa: F401,F403
from .text import *  # noqa: F401,F403
from .timing import *  # noqa: F401,F403
from .weather import *  # noqa: F401,F403
