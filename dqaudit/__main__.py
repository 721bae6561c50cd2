import sys

from dqaudit.cli import main

sys.exit(main())
