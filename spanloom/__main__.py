import sys

from spanloom.cli import main

sys.exit(main())
