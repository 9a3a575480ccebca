from ethersense.functions.columns import *  # noqa: F401,F403
