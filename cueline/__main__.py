from cueline.cli import main

raise SystemExit(main())
