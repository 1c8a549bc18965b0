"""python -m stratapack: see cli."""

import sys

from stratapack.cli import main

sys.exit(main())
