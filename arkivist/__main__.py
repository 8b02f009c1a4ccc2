import sys

from arkivist.cli import main

sys.exit(main())
