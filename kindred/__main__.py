from kindred.cli import main

raise SystemExit(main())
