import sys

from structura.run import main

sys.exit(main())
