import sys

from kgspark.commands import main

sys.exit(main())
