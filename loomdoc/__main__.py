import sys

from loomdoc.cli import main

sys.exit(main())
