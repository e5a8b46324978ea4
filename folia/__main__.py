import sys

from folia.plans.api import main

sys.exit(main())
