

from . import registry  # noqa: F401  before any of its modules, which register their queries with it
