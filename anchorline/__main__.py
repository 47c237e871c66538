from anchorline.plans.cli import main

raise SystemExit(main())
