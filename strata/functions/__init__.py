from strata.functions.ids import *  # noqa: F401,F403
from strata.functions.props import *  # noqa: F401,F403
from strata.functions.text import *  # noqa: F401,F403
