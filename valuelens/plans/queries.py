"""Registered queries: import every module that declares some."""

from valuelens.plans import q_stats  # noqa: F401
from valuelens.plans import q_clean  # noqa: F401
from valuelens.plans import q_models  # noqa: F401
from valuelens.plans import q_train  # noqa: F401
from valuelens.plans import q_value  # noqa: F401
from valuelens.plans import q_similar  # noqa: F401
from valuelens.plans import q_search  # noqa: F401
from valuelens.plans import q_sources  # noqa: F401
from valuelens.plans import q_selection  # noqa: F401
from valuelens.plans import q_single  # noqa: F401
