import sys

from quillmark.cli import main

sys.exit(main())
