import sys

from tabulon.cli import main

sys.exit(main())
