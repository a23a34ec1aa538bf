import sys

from tracklake.cli import main

sys.exit(main())
