"""The modules whose queries are registered."""

from quern.plans import q_metadata  # noqa: F401
from quern.plans import q_segments  # noqa: F401
from quern.plans import q_text  # noqa: F401
from quern.plans import q_signal  # noqa: F401
from quern.plans import q_sources  # noqa: F401
from quern.plans import q_composites  # noqa: F401
