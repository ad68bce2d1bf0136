from .columns import *  # noqa: F401,F403
from .columns import (ATTACK_FAMILIES, PROTOCOL_NAMES, PROTOCOL_NAMES_EXTENDED,  # noqa: F401
                      hash_order, hash_unit, literal_map)
